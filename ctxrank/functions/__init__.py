"""ctxrank.functions"""
