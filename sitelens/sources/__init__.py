"""Where rows come from and where answers go."""
