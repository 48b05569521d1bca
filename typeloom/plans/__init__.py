"""Schema documents, their component model and the checks made on it."""
