class QuernError(Exception):
    """What a statement does wrong: syntax, names, types, keys, locks."""
