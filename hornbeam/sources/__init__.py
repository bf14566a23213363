"""Tables in and out: stored intermediate results (``scratch``), files and registered tables (``files``)."""
