"""End-to-end plans for a session: recommend → homogenize → report."""
