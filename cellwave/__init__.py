"""cellwave: Spark jobs for per-sector radio traffic series."""
