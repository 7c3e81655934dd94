"""Documents from JSON: shapes, validation, typed rows."""
