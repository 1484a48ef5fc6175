"""glyphmill.plans"""
