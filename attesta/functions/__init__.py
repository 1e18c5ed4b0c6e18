"""attesta.functions"""
