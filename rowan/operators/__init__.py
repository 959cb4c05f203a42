"""rowan.operators"""
