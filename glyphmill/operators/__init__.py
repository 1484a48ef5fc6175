"""glyphmill.operators"""
