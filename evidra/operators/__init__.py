"""evidra.operators"""
