"""Running statistics over streams of lines."""
