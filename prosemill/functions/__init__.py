"""Text functions: pure Python on one document for what Catalyst lacks, and native Column expressions."""
