"""DataFrame operators; none of them collects, and none takes 'now' from the clock."""
