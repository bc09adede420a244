"""The per-file steps on streams: state is counts and timers, rows stay in tables."""
