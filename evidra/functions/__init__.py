"""evidra.functions"""
