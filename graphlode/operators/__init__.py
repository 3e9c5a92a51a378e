"""graphlode.operators"""
