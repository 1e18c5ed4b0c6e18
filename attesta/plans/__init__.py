"""attesta.plans"""
