"""From SQL text to a tree: tokens, grammar, and the text form of plans."""
