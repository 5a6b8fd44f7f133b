"""Column functions: coercion, text, masking, numbers and dates."""
