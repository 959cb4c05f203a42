"""rowan.plans"""
