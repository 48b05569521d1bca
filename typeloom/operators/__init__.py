"""Table operators: identity constraints, content models, assessment, CTA."""
