"""evidra.plans"""
