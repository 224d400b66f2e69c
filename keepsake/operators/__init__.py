"""DataFrame-to-DataFrame building blocks. None of them reads a clock or the storage of a backup."""
