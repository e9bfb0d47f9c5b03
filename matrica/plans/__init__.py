"""Named queries over a data folder, with the SQL that checks them."""
