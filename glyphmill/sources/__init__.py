"""glyphmill.sources"""
