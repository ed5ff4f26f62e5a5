"""Where rows come from: pages, indexes, lists, page snapshots."""
