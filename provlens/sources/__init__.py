"""Reading archive folders into tables and writing results back."""
