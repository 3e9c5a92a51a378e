"""graphlode.functions"""
