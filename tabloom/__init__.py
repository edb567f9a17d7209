"""tabloom: profile, clean, synthesize and score tables with PySpark."""
