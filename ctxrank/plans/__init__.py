"""ctxrank.plans"""
