"""rowan.streaming"""
