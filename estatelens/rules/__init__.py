"""Rule tables: plain data a user can replace."""
