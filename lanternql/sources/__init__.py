"""Where rows come from, and shared storage for intermediate ones."""
