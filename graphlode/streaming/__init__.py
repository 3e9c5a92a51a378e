"""graphlode.streaming"""
