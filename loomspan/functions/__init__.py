"""Part of loomspan; see the module docstrings."""
