"""attesta.sources"""
