"""Sources (CSV sessions, header catalogue, inline tables) and sinks."""
