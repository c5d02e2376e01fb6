"""DataFrame operators; each takes its columns and thresholds as arguments and works by key."""
