"""Records as text: templates, ready formats, drawings, sound files."""
