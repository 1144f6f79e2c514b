from depthkit.sources.views import events_log, lineitem_log, read_table  # noqa: F401
