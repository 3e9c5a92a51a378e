"""graphlode.sources"""
