"""Tables and schemas as text: delimited lines, JSON lines, INSERT statements, CREATE scripts, boxes."""
