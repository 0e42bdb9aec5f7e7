"""End-to-end presets that chain the operators."""
