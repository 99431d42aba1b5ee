"""evidra.sources"""
