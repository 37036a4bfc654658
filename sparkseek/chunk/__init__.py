"""Structure-aware chunks of TypeScript files."""
