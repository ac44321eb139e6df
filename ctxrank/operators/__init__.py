"""ctxrank.operators"""
