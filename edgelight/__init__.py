"""Edge-log triage and corpus preparation as Spark DataFrame programs."""
