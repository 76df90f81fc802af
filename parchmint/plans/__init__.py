

from . import catalog, service, whole  # noqa: F401  (service and whole add their queries to the catalogue)
