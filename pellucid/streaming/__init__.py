"""Health polling, and checks over streams of nodes."""
