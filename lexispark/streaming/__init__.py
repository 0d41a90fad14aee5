"""Wordlists that grow: new words arrive as a stream, and the sites of the cognate sets they touch are made anew."""
