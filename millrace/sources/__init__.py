"""Sources and sinks: files, lakes, databases, APIs and brokers."""

from . import apis, brokers, databases, documents, files, lakes, queues  # noqa: F401
