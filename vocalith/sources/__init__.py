"""Where rows come from: tables, pages, objects and change feeds."""
