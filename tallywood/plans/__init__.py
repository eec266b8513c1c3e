"""The data model: table schemas, category vocabulary and parameters."""
