"""Where rows come from and go to: labelled tables and streams, tab-separated text, key/value text and frames."""
