"""Archive sources: byte sources, recognition, formats, the reader and the data source."""
