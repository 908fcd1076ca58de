"""Work on sessions: typing, ordering, replaying, comparing, seeking and diagnosing."""
