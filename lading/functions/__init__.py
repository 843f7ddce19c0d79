"""Column functions (paths, names, dates, formatters) and byte kernels (checksums, ciphers, codecs)."""
