"""Plans: session settings, physical layout (writers) and pruning read helpers."""
