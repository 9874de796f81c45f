"""Row-to-row and relational operators over clinical notes."""
