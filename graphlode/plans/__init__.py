"""graphlode.plans"""
