"""attesta.operators"""
