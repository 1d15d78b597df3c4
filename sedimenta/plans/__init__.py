"""Plans that write: flush and compaction."""
