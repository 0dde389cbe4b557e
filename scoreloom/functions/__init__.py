"""Column functions: string, path, version, scope and number rules, all inside whole-stage code."""
