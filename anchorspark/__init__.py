"""Analytics over structured, citable text, expressed as lazy DataFrame transforms."""
