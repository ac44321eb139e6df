"""ctxrank.sources"""
