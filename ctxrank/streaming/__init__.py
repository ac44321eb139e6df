"""ctxrank.streaming"""
