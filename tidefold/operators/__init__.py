"""DataFrame operators: folding, scanning and segment maintenance."""
