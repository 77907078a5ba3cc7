"""Column functions; all are native Spark expressions that stay inside whole-stage codegen."""
