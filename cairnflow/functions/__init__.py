"""cairnflow package."""
