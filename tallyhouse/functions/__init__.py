"""Column functions: classification, pricing, text and validation rules."""
