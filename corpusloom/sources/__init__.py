"""Where a corpus comes from: file systems and tables."""
