"""glyphmill.functions"""
