"""Multi-stage plans: the commands of the engine."""
