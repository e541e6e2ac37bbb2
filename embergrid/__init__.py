"""embergrid: hotspot detection, fire-event tracking and text-corpus preparation as Spark jobs."""
