"""ctxrank: context retrieval and ranking over text scopes, as DataFrame transformations."""
