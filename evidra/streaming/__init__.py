"""evidra.streaming"""
