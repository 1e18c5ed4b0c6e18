"""attesta.streaming"""
