"""The rules: their catalogue, those that look at lines, and those that look at facts."""
