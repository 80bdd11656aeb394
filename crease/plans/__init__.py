"""Sessions and write layouts."""
