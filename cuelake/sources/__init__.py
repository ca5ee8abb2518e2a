"""Sources, sinks and adapters."""
