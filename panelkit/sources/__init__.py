"""Sources and sinks: table loading, fixture panels, stage persistence, report sinks."""
