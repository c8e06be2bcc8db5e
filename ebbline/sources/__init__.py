"""Tables of prices, bars, events and order flow, from files."""
